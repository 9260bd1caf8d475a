"""Readers of reference sets, evaluation runs and clip metadata files. Times become whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN_FORMAT = 1
_PIECE = "struct<source_start:double,source_end:double,short_start:double,short_end:double>"
_SET = (
    "episodes map<string,struct<path:string,title:string,duration_sec:double,size_bytes:bigint,sha256:string>>,"
    f"shorts array<struct<id:string,episode:string,pieces:array<{_PIECE}>,structure:struct<montage:boolean,reordered:boolean,source_span:array<double>>>>,"
    "pipeline_clip_labels array<struct<episode:string,clip_id:string,source_start:double,source_end:double,label:string>>"
)
_CLIP = "struct<clip_id:string,id:string,start_time:double,start:double,end_time:double,end:double,title:string,score:double>"
_RUN = f"format int,label string,episodes map<string,struct<job_id:string,status:string,clips:array<{_CLIP}>,reviews:map<string,string>>>"


def _ms(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1000).cast("long")


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")


def read_reference_sets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """JSON files of reference sets -> tables episodes, shorts, pieces and labels, with `file` in front.

    A file that is no JSON object gives no rows. Shorts without a structure are neither montages nor reordered;
    pieces keep their place in the file."""
    sets = _files(spark, path).select("file", F.from_json("value", _SET).alias("s"))
    shorts = sets.select("file", F.posexplode("s.shorts").alias("_at", "x"))
    number = F.row_number().over(Window.partitionBy("file", "x.episode").orderBy("_at")) - 1
    shorts = shorts.select("file", F.col("x.episode").alias("episode"), number.cast("long").alias("short_no"), "x")
    flag = lambda c: F.coalesce(F.col(f"x.structure.{c}"), F.lit(False)).alias(c)
    piece = lambda c: _ms(f"p.{c}").alias(f"{c}_ms")
    return {
        "episodes": sets.select("file", F.explode("s.episodes").alias("episode", "e")).select(
            "file", "episode", F.col("e.path").alias("path"), F.col("e.title").alias("title"), _ms("e.duration_sec").alias("duration_ms"), F.col("e.size_bytes").alias("bytes"), F.nullif(F.col("e.sha256"), F.lit("")).alias("sha256")
        ),
        "shorts": shorts.select("file", "episode", "short_no", F.col("x.id").alias("short_id"), flag("montage"), flag("reordered"), _ms(F.get("x.structure.source_span", F.lit(0))).alias("span_start_ms")),
        "pieces": shorts.select("file", "episode", "short_no", F.posexplode("x.pieces").alias("piece", "p")).select(
            "file", "episode", "short_no", "piece", piece("source_start"), piece("source_end"), piece("short_start"), piece("short_end")
        ),
        "labels": sets.select("file", F.explode("s.pipeline_clip_labels").alias("l")).select(
            "file", F.col("l.episode").alias("episode"), F.col("l.clip_id").alias("clip_id"), _ms("l.source_start").alias("start_ms"), _ms("l.source_end").alias("end_ms"), F.col("l.label").alias("label")
        ),
    }


def read_runs(spark: SparkSession, path: str, known: int = RUN_FORMAT) -> dict[str, DataFrame]:
    """JSON files of runs -> tables runs (run, label, readable), clips and reviews. The run is the file's name.

    A file that is no JSON object or of another format is not readable and gives no clips or reviews. A clip's id may
    stand under clip_id or id, its times under start_time and end_time or start and end; the title defaults to an
    empty text, the score to 0."""
    name = F.regexp_extract("file", r"^(.*?)(?:\.[^.]*)?$", 1)
    runs = _files(spark, path).select(name.alias("run"), F.from_json("value", _RUN).alias("r"))
    runs = runs.withColumn("readable", F.coalesce(F.col("r.format") == known, F.lit(False)))
    entries = runs.where("readable").select("run", F.explode("r.episodes").alias("episode", "e"))
    clips = entries.select("run", "episode", F.posexplode("e.clips").alias("place", "c"))
    either = lambda a, b: F.coalesce(F.col(f"c.{a}"), F.col(f"c.{b}"))
    return {
        "runs": runs.select("run", F.col("r.label").alias("label"), "readable"),
        "clips": clips.select(
            "run", "episode", F.col("place").cast("long").alias("clip_no"), either("clip_id", "id").alias("clip_id"), _ms(either("start_time", "start")).alias("start_ms"), _ms(either("end_time", "end")).alias("end_ms"),
            F.coalesce("c.title", F.lit("")).alias("title"), F.coalesce("c.score", F.lit(0.0)).alias("score"),
        ),
        "reviews": entries.select("run", "episode", F.explode("e.reviews").alias("clip_id", "status")),
    }


def read_clip_metadata(spark: SparkSession, path: str, clip_glob: str = "clip_*.mp4", suffix: str = ".meta.json") -> DataFrame:
    """The clip files of a folder, each with the JSON object beside it -> clip_id (the file's name), file, meta.

    meta is a map of the object's fields as texts, empty where the file beside is absent or broken. Files of clips are
    listed, not read."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", clip_glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    metas = _files(spark, path, f"*{suffix}").select(F.regexp_replace("file", suffix.replace(".", r"\.") + "$", "").alias("_id"), F.from_json("value", "map<string,string>").alias("_meta"))
    rows = listed.withColumn("clip_id", stem(F.col("file"))).join(metas.hint("merge"), F.col("clip_id") == F.col("_id"), "left")
    return rows.select("clip_id", "file", F.coalesce("_meta", F.create_map().cast("map<string,string>")).alias("meta"))
